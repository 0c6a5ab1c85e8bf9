"""Training-data pipeline operators: each module holds one operator and its own general interface."""
