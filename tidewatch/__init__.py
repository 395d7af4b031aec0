"""Flow-anomaly analytics as Spark jobs: flow scans, labels, features, forests, metrics, streams."""
