"""Jobs over DataFrames: write, restore, resolve, resume, report, reconcile."""
