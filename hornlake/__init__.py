"""hornlake: Horn-rule mining, inference and incremental maintenance over edge tables, on Spark DataFrames."""
