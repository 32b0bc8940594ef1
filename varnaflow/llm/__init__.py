"""Operators for preparing language-model training data.

One module per operator; ``queries`` registers them.  Nothing else in the
library imports this subpackage.
"""
