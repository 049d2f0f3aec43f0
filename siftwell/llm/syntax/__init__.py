"""Lexers, grammars and the chart machine behind the syntax operators."""
