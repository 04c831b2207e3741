"""Spark-native analytics over operational ticket tables."""
