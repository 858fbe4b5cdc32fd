"""Web-page block jobs on Spark: extraction, features, rules, directories, scoring and request decisions."""
