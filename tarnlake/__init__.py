"""tarnlake: a Spark-native engine for discovering tables in a lake of model documentation."""
