"""Basket analytics and recommendations expressed as Spark DataFrame jobs."""
