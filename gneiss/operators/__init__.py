"""Relational operators over findings, ledgers, symbols and graphs: DataFrame in, DataFrame out."""
