"""mediasift: Spark jobs over web-media delivery records."""
