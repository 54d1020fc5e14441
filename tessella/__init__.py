"""A PySpark-native engine for evaluating queries: profiles, result equality, votes, event logs and paired statistics."""
