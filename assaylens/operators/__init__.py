"""Relational and statistical operators over long (entity, response, feature) tables."""
