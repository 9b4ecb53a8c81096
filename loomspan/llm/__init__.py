"""Training-data operators: thirteen document operators that stand beside the analytics library.

Nothing outside this subpackage imports it.  Every module documents one operator; ``queries`` registers them.
"""
