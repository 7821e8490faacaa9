"""Connected components: the library's, under the name that the operators use."""

from pipeweave.operators.components import components

__all__ = ["components"]
