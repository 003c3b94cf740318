"""Errors. A problem of one slide becomes a row of the warnings table; one that blocks later steps is raised."""


class CueError(Exception):
    """Any error of this engine."""


class DeckParseError(CueError):
    """A deck can't be read."""


class InvalidInput(CueError, ValueError):
    """A parameter or table is not as it must be."""


class SynthesisError(CueError):
    """Speech can't be made."""


class SynthesisTimeout(SynthesisError, TimeoutError):
    """Speech takes too long."""


class ExportError(CueError):
    """A video can't be made."""


class ExportTimeout(ExportError, TimeoutError):
    """A video takes too long."""


class Unsupported(CueError, NotImplementedError):
    """An outside program that is not there: network speech, office automation, media conversion."""
