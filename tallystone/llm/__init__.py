"""Operators for preparing training text: ten operators over `documents` and `pages`.

Nothing else in the library imports this subpackage.
"""
