"""orefall: passage retrieval, guarded table analytics and corpus preparation on Spark."""
