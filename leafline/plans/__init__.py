"""The registered queries; importing the package fills the registry."""

from . import candidates, cascades, detection, documents, extraction, fields, forms, layout, pairs, reports, rules, streams, tables, templates, windows  # noqa: F401
