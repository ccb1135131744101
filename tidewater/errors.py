"""Error classes, one for each phase a statement passes through."""


class EngineError(Exception):
    """Any error of this engine."""


class ParseError(EngineError):
    """The text is no statement."""


class BindError(EngineError):
    """A name or a type doesn't fit."""


class PlanError(EngineError):
    """The statement is well formed but can't be planned."""


class RunError(EngineError):
    """The runtime refuses: wrong state, missing or existing object."""
