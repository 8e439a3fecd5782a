"""Line-scan analytics and corpus preparation as Spark DataFrame queries."""
