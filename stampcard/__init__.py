"""stampcard: campaign and loyalty measurement as Spark DataFrame operators."""
