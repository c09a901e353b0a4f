"""Operators for preparing training corpora; nothing else in lapwise imports this subpackage."""
