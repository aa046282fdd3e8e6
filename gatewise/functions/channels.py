"""Names of features: families, the parts of a name, and the name that a definition gives."""

from __future__ import annotations

import re
from collections.abc import Mapping

CHANNEL = re.compile(r"(?<![A-Za-z0-9])(Ch|M)(\d\d)(?![A-Za-z0-9])")


def channel(n: int, mask: bool = False) -> str:
    """The name of a channel's image, or of its own mask."""
    return f"{'M' if mask else 'Ch'}{n:02d}"


def feature_name(family: str, mask: str = "", image: str = "") -> str:
    return "_".join(x for x in (family, mask, image) if x)


#: Families of features by what they take.
FAMILIES = {
    "no parameters": ("Time", "Object Number", "Raw Centroid X", "Raw Centroid Y", "Flow Speed", "Camera Line Number", "Camera Timer", "Objects per mL", "Objects per sec"),
    "mask": ("Area", "Aspect Ratio", "Length", "Width", "Height", "Angle", "Centroid X", "Centroid Y", "Circularity", "Diameter", "Elongatedness", "Major Axis", "Minor Axis", "Perimeter", "Shape Ratio", "Spot Area Min", "Spot Distance Min", "Thickness Max", "Thickness Min"),
    "mask, image": (
        "Aspect Ratio Intensity", "Modulation", "Contrast", "Gradient RMS", "Intensity", "Mean Pixel", "Median Pixel", "Max Pixel", "Raw Max Pixel", "Raw Min Pixel", "Saturation Count", "Saturation Percent", "Bright Detail Intensity R3",
        "Bright Detail Intensity R7", "Angle Intensity", "Centroid X Intensity", "Centroid Y Intensity", "Compactness", "Gradient Max", "Internalization", "Lobe Count", "Major Axis Intensity", "Max Contour Position", "Min Pixel",
        "Minor Axis Intensity", "Raw Intensity", "Raw Mean Pixel", "Raw Median Pixel", "Spot Intensity Max", "Spot Intensity Min", "Std Dev", "Symmetry 2", "Symmetry 3", "Symmetry 4", "Uncompensated Intensity", "Valley X", "Valley Y",
    ),
    "image": ("Bkgd Mean", "Bkgd StdDev"),
    "mask, image, scalar": (*(f"H {x} {y}" for x in ("Contrast", "Correlation", "Energy", "Entropy", "Homogeneity", "Variance") for y in ("Mean", "Std")), "Granularity:"),
    "mask, scalar": ("Spot Count",),
    "mask, three images": ("Bright Detail Colocalization 3",),
    "mask, two images": ("Bright Detail Similarity R3", "Shift X", "Shift Y", "Similarity", "XCorr"),
    "two masks, two images": ("Delta Centroid X", "Delta Centroid Y", "Delta Centroid XY"),
    "two masks, image": ("Intensity Concentration Ratio",),
    "image, scalar": ("Ensquared Energy", "Diameter:"),
}
#: Scalars that names leave out where they are the usual ones.
USUAL = (("Granularity:", "1", "20"), ("Diameter:", "1", "20"), ("False", "1", "20"), ("True", "8", "4"), ("", "1", "20"))


def family_kind(definition: str) -> str | None:
    """What the family that a definition begins with takes; None if there is no such family."""
    first = definition.split("|")[0]
    return next((kind for kind, names in FAMILIES.items() if first in names), None)


def default_feature_name(definition: str, combined: bool = False) -> str:
    """The name that a definition gives its feature."""
    parts = definition.split("|")
    if combined:
        return " ".join(parts)
    parts = ["IntensityWeighted" if p == "true" else p for p in parts if p != "false"]
    for run in USUAL:
        n = len(run)
        at = next((i for i in range(len(parts) - n + 1) if tuple(parts[i : i + n]) == run), None)
        if at is not None:
            del parts[at : at + n]
    return "_".join(p for p in parts if p)


def feature_parts(name: str, masks: set[str], images: set[str]) -> tuple[str, str, str]:
    """Family, mask and image of a feature's name; empty where it names none. Mask and
    image names may hold underscores; the longest known one counts."""
    family, mask, image = name, "", ""
    for known in sorted(images, key=len, reverse=True):
        if family.endswith("_" + known):
            family, image = family.removesuffix("_" + known), known
            break
    for known in sorted(masks, key=len, reverse=True):
        if family.endswith("_" + known):
            family, mask = family.removesuffix("_" + known), known
            break
    return family, mask, image


def with_channels(definition: str, channels: Mapping[int, int], masks: bool = True) -> str:
    """A definition (feature, mask or image) with other channels; all change at once, so
    two can be swapped. Without ``masks`` only images change."""

    def put(m: re.Match) -> str:
        new = channels.get(int(m[2]), int(m[2]))
        return m[0] if m[1] == "M" and not masks else f"{m[1]}{new:02d}"

    return CHANNEL.sub(put, definition)
