"""Training-data operators: ten corpus-scale transforms and their registered queries."""
