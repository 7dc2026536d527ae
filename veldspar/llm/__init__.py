"""Training-data operators: identification, filtering, de-duplication, mixing and extraction of documents."""
