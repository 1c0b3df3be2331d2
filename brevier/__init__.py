"""Brevier: article, audience and corpus analytics expressed as Spark plans."""
