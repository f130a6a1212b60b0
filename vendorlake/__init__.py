"""vendorlake: vendor file drops to tested tables and marts, on Spark."""
