"""Query language: parser, syntax tree, and compilation to DataFrame plans."""
