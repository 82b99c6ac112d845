"""Graph, tree, span, fixpoint and change-set operators (DataFrame in, DataFrame out)."""
