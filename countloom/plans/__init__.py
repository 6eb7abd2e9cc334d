"""Feature pipelines, models, evaluation and the registered queries."""
