"""Insurance and billing analytics on PySpark, with operators for training-data pipelines."""
