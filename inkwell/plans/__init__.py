"""Named queries, each beside its SQL; all are registered in their order whichever module is asked for first."""

from inkwell.plans import registry  # noqa: F401
