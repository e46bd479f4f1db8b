"""Graph, probability, hierarchy, layout and evaluation operators."""
