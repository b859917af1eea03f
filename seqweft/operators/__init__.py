"""Relational operators: DataFrame -> DataFrame, lazy, parameterised by column names."""
