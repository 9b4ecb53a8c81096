"""Connected components, which the library outside of this removable part has too."""

from loomspan.operators.components import components

__all__ = ["components"]
