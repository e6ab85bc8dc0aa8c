"""seatrace: vessel tracks, seabed lines and parameter sweeps as Spark DataFrame operators."""
