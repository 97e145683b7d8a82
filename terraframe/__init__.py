"""terraframe: DataFrame operators for aerial point-cloud surveys on Spark."""
