"""Line formats of embeddings and points."""
