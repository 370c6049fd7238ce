"""Session analytics for shop clickstreams, written as Spark DataFrame operators."""
