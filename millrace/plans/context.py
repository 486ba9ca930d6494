"""What the steps of a pipeline share on the driver."""

from __future__ import annotations


class Context(dict):
    """Keys and values, with lists of errors and steps and the SQL parameters."""

    def __init__(self, **values):
        super().__init__({"errors": [], "steps": [], "sqlparams": {}} | values)
