"""Training-data operators: ten document-scale operations and their registered queries."""
