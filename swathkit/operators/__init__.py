"""Catalogues, insertion of new products, statistics."""
