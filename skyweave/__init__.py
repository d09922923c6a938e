"""Unit-aware scientific catalogues on Spark DataFrames."""

from .collections.healpix_map import HealpixMap
from .collections.lightcone import Lightcone
from .collections.simulation import SimulationCollection
from .collections.structure import StructureCollection, link
from .functions.errors import MissingColumnError, UnitConversionError, UnitsError
from .functions.expr import add_mag_cols, col, norm_cols, offset_3d
from .functions.units import Quantity, u
from .operators.dataset import Dataset, Evaluated
from .plans.regions import make_box, make_cone, make_skybox
from .sources.catalog import open, write, write_parquet
from .sources.header import Header

__all__ = [
    "Dataset", "Evaluated", "Header", "HealpixMap", "Lightcone", "MissingColumnError", "Quantity", "SimulationCollection", "StructureCollection", "UnitConversionError", "UnitsError",
    "add_mag_cols", "col", "link", "make_box", "make_cone", "make_skybox", "norm_cols", "offset_3d", "open", "u", "write", "write_parquet",
]
