"""Analytics over ordered collections (playlists), expressed as Spark DataFrames."""
