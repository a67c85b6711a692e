"""relaylog: Spark-native analytics over message-exchange logs."""

__version__ = "0.1.0"
