"""Sources and sinks: archives, images, raw bytes."""
