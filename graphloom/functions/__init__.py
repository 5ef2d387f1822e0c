"""Column functions; everything here is JVM-side unless it says otherwise."""
