"""Catalogia: Spark jobs for multi-supplier product catalogues."""
