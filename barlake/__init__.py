"""Spark-native market-data lakehouse: ticks, candles, daily bars and boards."""
