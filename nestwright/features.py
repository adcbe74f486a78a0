"""Features that are refused unless a caller asks for them to be ignored."""

from __future__ import annotations

_IGNORED = dict.fromkeys(("array_filters", "collation", "let", "session"), False)


def _known(feature: str) -> None:
    if feature not in _IGNORED:
        raise KeyError(f"{feature} can't be ignored; these can: {', '.join(_IGNORED)}")


def ignore_feature(feature: str) -> None:
    """From now on the feature is passed over in silence."""
    _known(feature)
    _IGNORED[feature] = True


def warn_on_feature(feature: str) -> None:
    """From now on the feature raises, as at first."""
    _known(feature)
    _IGNORED[feature] = False


def refuse(feature: str, value) -> None:
    """Raises for a feature that is asked for and not ignored."""
    _known(feature)
    if value is not None and not _IGNORED[feature]:
        raise NotImplementedError(f"the option {feature} is not supported")
