"""All query modules; importing them registers their queries."""

from barloom.plans import backtest_queries, calendar_queries, column_queries, feature_queries, gate_queries, learning_queries, market_queries, model_queries, quality_queries, section_queries, serving_queries, source_queries, store_queries, text_queries, valence_queries  # noqa: F401
