"""One hierarchy of errors; every failure of a tree operation is a ``TreeError``."""


class TreeError(Exception):
    pass


class ConfigurationError(TreeError, ValueError):
    """An aggregate, path or tree is declared in a way that has no meaning."""


class SourceConstraintError(TreeError):
    """A source column breaks what its aggregate needs (a positive value, say)."""


class CorruptTreeError(TreeError):
    """Rows cannot be reached from a root: orphans or cycles."""


class CyclicMoveError(TreeError):
    pass


class ScopeViolationError(TreeError):
    pass


class UnplacedNodeError(TreeError):
    pass


class MissingNodeError(TreeError, KeyError):
    pass


class AmbiguousNodeError(TreeError):
    """An id that rows of several scopes share, given without a scope."""


class TrashedTargetError(TreeError):
    pass


class TrashedAncestorError(TreeError):
    pass


class SiblingOrderError(TreeError, ValueError):
    pass


class CloneTargetError(TreeError):
    pass


class PathError(TreeError):
    pass


class EmptySegmentError(PathError):
    pass


class InvalidSegmentError(PathError):
    pass


class DuplicateSegmentError(PathError):
    pass


class PathTooLongError(PathError):
    pass


class JsonTreeError(TreeError, ValueError):
    pass


class KeyCollisionError(JsonTreeError):
    pass


class DuplicateIdentityError(TreeError, ValueError):
    pass


class DanglingParentError(TreeError, ValueError):
    pass
