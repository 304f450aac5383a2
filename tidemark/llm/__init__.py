"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; the registration module looks for
it and works without it.
"""
