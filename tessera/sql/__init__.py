"""The SQL dialect: text to statements (parser), statements to DataFrames (compiler)."""
