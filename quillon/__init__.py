"""quillon: controlled-comparison analytics and data preparation on PySpark."""
