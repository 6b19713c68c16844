"""Theme palettes of office packages, and colours given by theme, tint or brightness."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.kernels import color
from .xml import Package, every, local

# The order in which spreadsheets number a theme's colours (the first two pairs are swapped).
SHEET_ORDER = ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")


def palette(data: bytes, custom: Callable[[str], str | None] | None = None) -> dict[str, str]:
    """Colours of the package's first theme as six hex digits by name; custom may answer first."""
    pkg = Package(data)
    part = next((n for n in sorted(pkg.names) if "/theme/" in n and n.endswith(".xml")), None)
    out: dict[str, str] = {}
    for scheme in every(pkg.xml(part), "clrScheme")[:1] if part else ():
        for e in scheme:
            value = next((c.get("val") if local(c) == "srgbClr" else c.get("lastClr") for c in e), None)
            own = custom(local(e)) if custom else None
            out[local(e)] = own or value or "000000"
    return out


def tinted(rgb: str, tint: float) -> str:
    """A colour made lighter (tint above 0) or darker, in equal parts of each channel."""
    _, *channels = color(rgb)
    mixed = [c + (255 - c) * tint if tint > 0 else c * (1 + tint) for c in channels]
    return "".join(f"{max(0, min(255, round(c))):02X}" for c in mixed)


def sheet_color(colors: dict[str, str], index: int, tint: float = 0.0) -> str | None:
    """A spreadsheet's theme colour by its number."""
    name = SHEET_ORDER[index] if 0 <= index < len(SHEET_ORDER) else None
    return tinted(colors[name], tint) if name in colors else None
