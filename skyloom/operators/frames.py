"""Spectral frames: the velocity of an observer towards a source, as column expressions of time, site and direction.

The Earth's orbit is a Kepler ellipse with mean elements of the date, referred to the equinox of J2000; the Moon, Jupiter and
Saturn shift the Earth and the Sun on circles. Velocities are good to about 3 m/s (1e-8 of a frequency) from 1980 to 2050.
Nothing is looked up and no table is joined: the Doppler factor is computed where a sample is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibration import lsr_factor, regridded

#: Longitude (east, degrees), latitude (degrees) and height (metres) of telescopes.
SITES = {
    "ALMA": (-67.754929, -23.022886, 5053.0),
    "VLA": (-107.618283, 34.078749, 2124.0),
    "EVLA": (-107.618283, 34.078749, 2124.0),
    "GBT": (-79.839833, 38.433119, 807.0),
    "WSRT": (6.633, 52.9153, 16.0),
    "MEERKAT": (21.4430, -30.7130, 1086.6),
}
#: Unix seconds of the epoch 2000 January 1.5, and seconds from coordinated to terrestrial time since 2017.
EPOCH, TERRESTRIAL = 946728000.0, 69.184
#: The Earth's orbit: speed (m/s), eccentricity, and degrees with degrees a century of the Sun's mean longitude,
#: its mean anomaly, the perihelion, and of precession in longitude.
ORBIT_SPEED, ECCENTRICITY = 29785.9, (0.016708634, -0.000042037)
SUN_LONGITUDE, SUN_ANOMALY, PERIHELION, PRECESSION = (280.46646, 36000.76983), (357.52911, 35999.05029), (102.93735, 1.71946), 1.396971
#: The equation of the centre in degrees: sine of one, two and three anomalies.
CENTRE = (1.914602, 0.019993, 0.000289)
#: Speed (m/s), longitude (degrees) and motion (degrees a century) of what shifts the Earth and the Sun: the Moon,
#: Jupiter, Saturn.
SHIFTS = ((12.44, 218.3165, 481267.8812), (12.48, 34.3515, 3034.9057), (2.76, 50.0774, 1222.1138))
#: Obliquity of the ecliptic in J2000 (degrees); rotation of the Earth: turns at the epoch, turns a day, rad/s;
#: equatorial radius (m) and flattening.
OBLIQUITY = 23.4392911
ROTATION, SPIN = (0.7790572732640, 1.00273781191135448), 7.292115e-5
RADIUS, FLATTENING = 6378137.0, 1 / 298.257223563
#: Galactic pole (right ascension, declination) and the longitude of the celestial pole, degrees in J2000.
GALACTIC = (192.85948, 27.12825, 122.93192)
#: Motion of the Sun: kinematic (m/s towards a right ascension and declination of J2000, degrees); dynamical and
#: about the galactic centre (m/s towards the centre, along rotation, to the pole); tilt of the plane for the last.
KINEMATIC = (20000.0, 270.959542, 30.004667)
DYNAMICAL, GALACTOCENTRIC, TILT = (9000.0, 12000.0, 7000.0), (12900.0, 245600.0, 7780.0), math.asin(20.8 / 8122)


def galactic_to_equatorial(vector: tuple[float, float, float]) -> tuple[float, float, float]:
    """A galactic vector (centre, rotation, pole) in equatorial axes of J2000."""
    ra, dec, pole = map(math.radians, GALACTIC)
    z = (math.cos(dec) * math.cos(ra), math.cos(dec) * math.sin(ra), math.sin(dec))
    north = (-math.sin(dec) * math.cos(ra), -math.sin(dec) * math.sin(ra), math.cos(dec))  # at the galactic pole
    east = (-math.sin(ra), math.cos(ra), 0.0)
    # The celestial pole stands at the galactic longitude ``pole``: that is where ``north`` points.
    x = tuple(math.cos(pole) * n + math.sin(pole) * e for n, e in zip(north, east))
    y = tuple(math.sin(pole) * n - math.cos(pole) * e for n, e in zip(north, east))
    return tuple(vector[0] * a + vector[1] * b + vector[2] * c for a, b, c in zip(x, y, z))


def sun_velocity(frame: str) -> tuple[float, float, float]:
    """The Sun's velocity (m/s, equatorial axes) in ``lsrk``, ``lsrd``, ``bary`` or ``galacto``."""
    frame = frame.lower()
    if frame == "lsrk":
        speed, ra, dec = KINEMATIC[0], math.radians(KINEMATIC[1]), math.radians(KINEMATIC[2])
        return (speed * math.cos(dec) * math.cos(ra), speed * math.cos(dec) * math.sin(ra), speed * math.sin(dec))
    if frame == "lsrd":
        return galactic_to_equatorial(DYNAMICAL)
    if "bary" in frame:
        return (0.0, 0.0, 0.0)
    if "galacto" in frame:
        x, y, z = GALACTOCENTRIC
        return galactic_to_equatorial((x * math.cos(TILT) - z * math.sin(TILT), y, x * math.sin(TILT) + z * math.cos(TILT)))
    raise ValueError(f"unknown spectral frame {frame!r}; known are lsrk, lsrd, bary, galacto")


def _circle(speed: float, angle: Column) -> tuple[Column, Column]:
    return speed * F.sin(angle), -speed * F.cos(angle)


def orbital_velocity(t: Column) -> tuple[Column, Column, Column]:
    """The Earth's velocity about the barycentre (m/s, equatorial axes of J2000) at Unix seconds ``t``."""
    century = (t - EPOCH + TERRESTRIAL) / (86400.0 * 36525)
    angle = lambda start, rate: F.radians(F.lit(start) + century * (rate - PRECESSION))
    anomaly = F.radians(F.lit(SUN_ANOMALY[0]) + century * SUN_ANOMALY[1])
    centre = sum((F.lit(c) * F.sin(anomaly * k) for k, c in enumerate(CENTRE[1:], 2)), F.lit(CENTRE[0]) * F.sin(anomaly))
    sun, e = angle(*SUN_LONGITUDE) + F.radians(centre), F.lit(ECCENTRICITY[0]) + century * ECCENTRICITY[1]
    perihelion = angle(*PERIHELION)
    x = ORBIT_SPEED * (F.sin(sun) - e * F.sin(perihelion))
    y = -ORBIT_SPEED * (F.cos(sun) - e * F.cos(perihelion))
    for speed, start, rate in SHIFTS:
        dx, dy = _circle(speed, angle(start, rate))
        x, y = x + dx, y + dy
    tilt = math.radians(OBLIQUITY)
    return x, y * math.cos(tilt), y * math.sin(tilt)


def spin_velocity(t: Column, site: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    """The velocity of a site (longitude, latitude in degrees, height in metres) by the Earth's rotation."""
    lat = math.radians(site[1])
    squash = (1 - FLATTENING) ** 2
    axis = RADIUS / math.sqrt(math.cos(lat) ** 2 + squash * math.sin(lat) ** 2)
    speed = SPIN * (axis + site[2]) * math.cos(lat)
    days = (t - EPOCH) / 86400.0
    turn = F.lit(2 * math.pi) * (F.lit(ROTATION[0]) + days * ROTATION[1]) + math.radians(site[0])
    return -speed * F.sin(turn), speed * F.cos(turn), F.lit(0.0)


def velocity(t: Column, site: str | tuple[float, float, float], ra: Column | float, dec: Column | float, frame: str = "lsrk") -> Column:
    """Metres a second at which an observer at ``site`` moves towards (``ra``, ``dec``: radians, J2000) in ``frame``."""
    if isinstance(site, str):
        if site.upper() not in SITES:
            raise ValueError(f"unknown telescope {site!r}; known are {sorted(SITES)}")
        site = SITES[site.upper()]
    ra, dec = (c if isinstance(c, Column) else F.lit(float(c)) for c in (ra, dec))
    towards = F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec)
    parts = zip(orbital_velocity(t), spin_velocity(t, site), sun_velocity(frame), towards)
    return sum(((o + s + sun) * d for o, s, sun, d in parts), F.lit(0.0))


def doppler_factor(t: Column, site: str | tuple[float, float, float], ra: Column | float, dec: Column | float, frame: str = "lsrk") -> Column:
    """What an observed frequency is multiplied with to give that in ``frame``."""
    return lsr_factor(velocity(t, site, ra, dec, frame))


def frame_channels(moved: DataFrame, channels: int) -> DataFrame:
    """``out_freq``: as many evenly spaced frequencies as there are ``channels``, from the lowest of ``moved(freq)`` on, over
    the range that they take through time."""
    ends = moved.agg(F.min("freq").alias("low"), F.max("freq").alias("high"))  # one row
    step = (F.col("high") - F.col("low")) / channels
    numbered = ends.select("low", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("k"))
    return numbered.select((F.col("low") + F.col("k") * F.col("step")).alias("out_freq"))


def to_frame(vis: DataFrame, site: str | tuple[float, float, float], ra: Column | float, dec: Column | float, frame: str = "lsrk", channels: int | None = None, keys: tuple[str, ...] = ("t", "ant1", "ant2", "pol")) -> DataFrame:
    """``keys, out_freq, re, im, weight``: visibilities and weights of observed (topocentric) frequencies on an even axis of
    ``frame``, by linear interpolation; 0 beyond the channels of a time. ``t`` is in Unix seconds. ``channels``: as many as
    the data have, where not given."""
    moved = vis.withColumn("freq", F.col("freq") * doppler_factor(F.col("t"), site, ra, dec, frame))
    count = channels or vis.select("freq").distinct().count()
    return regridded(moved, frame_channels(moved, count), keys)
