"""Mail and claim-document analytics as Spark DataFrame transformations."""
