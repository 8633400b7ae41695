"""emporio: e-commerce warehouse, reporting, dashboards, forecasting and
customer segmentation as Spark DataFrame / SQL / pyspark.ml jobs."""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers (pandas UDFs)
    never need emporio on their own path -- e.g. executors of a cluster that
    only received the driver program."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: fall back to import by name
        pass


_ship_by_value()
