"""Data curation and classifier evaluation for content moderation, on Spark."""
