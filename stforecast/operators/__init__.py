"""Panel, block, model and evaluation operators."""
