"""Registered queries of the engine's own operators, by area; each module has ``QUERIES`` and ``ORACLES``."""

from gridloom.plans import datasets, evaluation, export, extras, geometry, images, live, masks, search, shapes, tracking, variants, zones

PLANS = [geometry, evaluation, zones, datasets, search, export, tracking, shapes, extras, variants, masks, images, live]
