"""Web-visibility analytics and text-data operators on Spark."""
