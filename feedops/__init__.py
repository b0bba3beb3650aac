"""feedops: media-feed curation as Spark DataFrame operators."""
