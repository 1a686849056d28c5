"""Site settings and fixed sensor values."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the sensors and of the photon conversion.
CHANNELS = ("f415", "f445", "f480", "f515", "f555", "f590", "f630", "f680")
RESPONSE = {"f415": 55, "f445": 110, "f480": 210, "f515": 390, "f555": 590, "f590": 840, "f630": 1350, "f680": 1070}
WAVELENGTH = {"f415": 415, "f445": 445, "f480": 480, "f515": 515, "f555": 555, "f590": 590, "f630": 630, "f680": 680}
NIR_CHANNELS = ("n610", "n680", "n730", "n760", "n810", "n860")
LUX_PER_PPFD = 54.0
PHOTONS_PER_WATT_NM = 0.00836
F415_COUNTS, F415_IRRADIANCE, F415_GAIN, F415_MS = 3200.0, 0.57, 512.0, 100.0
FULL_SCALE, DEVICE_SATURATED, AMBIENT_LEAK = 65535.0, 65000.0, 2000.0


@dataclass(frozen=True)
class Site:
    """What a job needs to know about a place. Minutes are minutes of the local day."""

    tz: str = "Asia/Taipei"
    lat: float = 25.01
    lon: float = 121.46
    lamp_start: int = 480
    lamp_end: int = 1110
    extend_end: int = 1230
    lux_on_below: float = 5000.0
    lux_off_above: float = 15000.0
    dli_target: float = 4.0
    stale_s: int = 300
    min_hold_s: int = 300
    manual_hold_s: int = 300
    tick_s: int = 60


SITE = Site()
