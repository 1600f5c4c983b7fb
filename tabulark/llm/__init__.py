"""Operators for preparing training data for language models.

Nothing else in the package imports this one. Texts are whole and never cut to a prefix; a
null text counts as empty unless an operator says otherwise.
"""
