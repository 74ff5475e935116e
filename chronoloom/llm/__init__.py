"""Operations of a training-data pipeline on Spark DataFrames; nothing else in the library imports this subpackage."""
