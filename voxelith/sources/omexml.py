"""OME-XML: images, pixels, channels and instruments, whatever the namespace."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field


@dataclass(frozen=True)
class XmlChannel:
    id: str | None
    name: str | None
    color: int | None
    samples_per_pixel: int | None
    emission_wavelength: float | None
    excitation_wavelength: float | None
    fluor: str | None


@dataclass(frozen=True)
class Pixels:
    id: str | None
    dimension_order: str | None
    type: str | None
    size_x: int | None
    size_y: int | None
    size_z: int | None
    size_c: int | None
    size_t: int | None
    physical_size_x: float | None
    physical_size_y: float | None
    physical_size_z: float | None
    physical_size_x_unit: str
    physical_size_y_unit: str
    physical_size_z_unit: str
    time_increment: float | None
    time_increment_unit: str
    channels: tuple[XmlChannel, ...]


@dataclass(frozen=True)
class Objective:
    id: str | None
    model: str | None
    manufacturer: str | None
    nominal_magnification: float | None
    lens_na: float | None
    immersion: str | None


@dataclass(frozen=True)
class Instrument:
    id: str
    objectives: tuple[Objective, ...]


@dataclass(frozen=True)
class Image:
    id: str | None
    name: str | None
    description: str | None
    acquisition_date: str | None
    pixels: Pixels | None
    instrument_id: str | None
    objective_id: str | None


@dataclass(frozen=True)
class OmeXml:
    images: tuple[Image, ...]
    instruments: dict[str, Instrument] = field(hash=False, default_factory=dict)

    def instrument_of(self, image: Image) -> Instrument | None:
        return self.instruments.get(image.instrument_id) if image.instrument_id else None

    def objective_of(self, image: Image) -> Objective | None:
        own = self.instrument_of(image)
        return next((o for o in own.objectives if o.id == image.objective_id), None) if own and image.objective_id else None


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [c for c in e if _local(c) == name] if e is not None else []


def _one(e: ET.Element | None, name: str) -> ET.Element | None:
    return next(iter(_all(e, name)), None)


def _text(e: ET.Element | None) -> str | None:
    return e.text.strip() if e is not None and e.text and e.text.strip() else None


def _float(e: ET.Element, name: str) -> float | None:
    try:
        return float(e.get(name))
    except (TypeError, ValueError):
        return None


def _int(e: ET.Element, name: str) -> int | None:
    try:
        return int(e.get(name))
    except (TypeError, ValueError):
        return None


def _channel(c: ET.Element) -> XmlChannel:
    return XmlChannel(c.get("ID"), c.get("Name"), _int(c, "Color"), _int(c, "SamplesPerPixel"), _float(c, "EmissionWavelength"), _float(c, "ExcitationWavelength"), c.get("Fluor"))


def _pixels(p: ET.Element | None) -> Pixels | None:
    if p is None:
        return None
    sizes = [_int(p, f"Size{a}") for a in "XYZCT"]
    lengths = [_float(p, f"PhysicalSize{a}") for a in "XYZ"]
    units = [p.get(f"PhysicalSize{a}Unit", "µm") for a in "XYZ"]
    return Pixels(p.get("ID"), p.get("DimensionOrder"), p.get("Type"), *sizes, *lengths, *units, _float(p, "TimeIncrement"), p.get("TimeIncrementUnit", "s"), tuple(_channel(c) for c in _all(p, "Channel")))


def parse(text: str | bytes) -> OmeXml:
    """Direct children only; bad numbers are None; of instruments with one ID the last counts."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError(f"bad OME-XML: {e}") from e
    images = []
    for i in _all(root, "Image"):
        instrument, objective = _one(i, "InstrumentRef"), _one(i, "ObjectiveSettings")
        images.append(Image(i.get("ID"), i.get("Name"), _text(_one(i, "Description")), _text(_one(i, "AcquisitionDate")), _pixels(_one(i, "Pixels")), instrument.get("ID") if instrument is not None else None, objective.get("ID") if objective is not None else None))
    tools = {}
    for n in _all(root, "Instrument"):
        if n.get("ID"):
            lenses = tuple(Objective(o.get("ID"), o.get("Model"), o.get("Manufacturer"), _float(o, "NominalMagnification"), _float(o, "LensNA"), o.get("Immersion")) for o in _all(n, "Objective"))
            tools[n.get("ID")] = Instrument(n.get("ID"), lenses)
    return OmeXml(tuple(images), tools)


def try_parse(text: str | bytes | None) -> OmeXml | None:
    try:
        return parse(text) if text else None
    except (ValueError, TypeError):
        return None
