"""Reading, deriving, flattening and writing the three signals."""
