"""Registered queries; the registry imports the modules in order, whichever comes first."""

import tickloom.registry  # noqa: F401
