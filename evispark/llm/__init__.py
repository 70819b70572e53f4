"""Operators for preparing training text: ten independent operators and the helpers they share."""
