"""kinetable: skeleton keypoint tables, fall events and the datasets around them, on Spark."""
