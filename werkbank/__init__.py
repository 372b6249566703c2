"""Commerce, inventory and support analytics as Spark DataFrame operators."""
