"""tablescout: data profiling and exploration as lazy Spark DataFrame operators."""
