"""Plumbline: what every step of a Spark pipeline does to its data, plus the operators of a training-data pipeline."""
