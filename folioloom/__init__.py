"""folioloom: document analytics and entity resolution as PySpark DataFrame transforms."""
