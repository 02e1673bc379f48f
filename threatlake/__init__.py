"""threatlake: network-threat analytics as PySpark DataFrame, ML and streaming jobs."""
