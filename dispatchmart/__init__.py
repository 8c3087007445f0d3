"""Taxi-dispatch data mart expressed as Spark table and stream jobs."""
