"""Spark-native analytics over news articles: cleaning, enrichment, reports, graphs and corpus operators."""
