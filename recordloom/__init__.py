"""recordloom: a PySpark-native engine over keyed record tables."""
