"""Invented dead-letter content for the test views: eight stack traces, the
payload type ids, the reason-code rows.  ``{n}`` in a trace is replaced by a
per-record line number so that fingerprints are seen to ignore it."""

TRACES = [
    # 0: business exception with a code, three links, multi-line message.
    "org.springframework.kafka.listener.ListenerExecutionFailedException: Listener method threw exception\n"
    "\tat org.springframework.kafka.listener.KafkaMessageListenerContainer.decorate(KafkaMessageListenerContainer.java:{n})\n"
    "\tat java.base/java.lang.Thread.run(Thread.java:840)\n"
    "Caused by: java.lang.RuntimeException: wrapped\n"
    "\tat com.example.app.consumer.BaseConsumer.lambda$consume$0(BaseConsumer.java:{n})\n"
    "\tat com.example.app.consumer.BaseConsumer$$SpringCGLIB$$0.consume(<generated>)\n"
    "\t... 3 more\n"
    "Caused by: com.example.app.common.BusinessException: [REF_DATA_NOT_FOUND] reference data missing\n"
    "for packet\n"
    "\tat com.example.app.common.ErrorFactory.create(ErrorFactory.java:{n})\n"
    "\tat com.example.app.dedup.DedupServiceImpl.lookupMaster(DedupServiceImpl.java:{n})\n"
    "\tat jdk.internal.reflect.GeneratedMethodAccessor12.invoke(Unknown Source)\n"
    "\tat com.example.app.dedup.DedupServiceImpl.filterCandidates(DedupServiceImpl.java:{n})\n"
    "\tat com.example.app.dedup.DedupServiceImpl$$SpringCGLIB$$1.filterCandidates(<generated>)\n"
    "\tat com.example.app.flow.Pipeline.run(Pipeline.java:{n})\n"
    "\tat com.example.app.flow.Pipeline.step(Pipeline.java:{n})\n"
    "\tat com.example.app.flow.Pipeline.stepTwo(Pipeline.java:{n})\n"
    "\tat com.example.app.flow.Pipeline.stepThree(Pipeline.java:{n})\n"
    "\t... 12 more",
    # 1: business exception whose code the catalog declares technical.
    "com.example.app.common.BusinessException: [KAFKA_PUBLISH_FAILED] could not publish\n"
    "\tat com.example.app.publish.Publisher.send(Publisher.java:{n})\n"
    "\tat com.example.app.publish.Publisher$$EnhancerBySpringCGLIB$$9.send(<generated>)\n"
    "\tat java.base/java.util.concurrent.FutureTask.run(FutureTask.java:317)",
    # 2: code defect behind a wrapper.
    "org.springframework.kafka.listener.ListenerExecutionFailedException: Listener failed\n"
    "\tat org.springframework.kafka.listener.Adapter.invoke(Adapter.java:{n})\n"
    "Caused by: java.lang.NullPointerException: Cannot invoke \"String.length()\" because \"s\" is null\n"
    "\tat com.example.app.util.Strings.len(Strings.java:{n})\n"
    "\tat com.example.app.flow.Step.apply(Step.java:{n})\n"
    "\tat com.sun.proxy.$Proxy45.apply(Unknown Source)\n"
    "\t... 7 more",
    # 3: technical fault matched by a package prefix.
    "java.lang.RuntimeException: io failure\n"
    "\tat com.example.app.client.Http.call(Http.java:{n})\n"
    "Caused by: javax.net.ssl.SSLHandshakeException: PKIX path building failed\n"
    "\tat java.base/sun.security.ssl.Alert.createSSLException(Alert.java:130)\n"
    "\tat com.example.app.client.Http.connect(Http.java:{n})",
    # 4: unknown exception, with a suppressed block.
    "com.example.app.custom.WeirdFailure: something odd\n"
    "\tat com.example.app.custom.Thing.doIt(Thing.java:{n})\n"
    "\tSuppressed: java.io.IOException: close failed\n"
    "\t\tat com.example.app.io.Closer.close(Closer.java:{n})\n"
    "\tat com.example.app.custom.Runner.run(Runner.java:{n})",
    # 5: cut short after the last header.
    "java.lang.IllegalStateException: outer\n"
    "\tat com.example.app.state.Machine.next(Machine.java:{n})\n"
    "Caused by: com.example.app.common.BusinessException: [PACKET_STATUS_INVALID] bad status",
    # 6: no trace at all (header absent); the code sits in the message header.
    "",
    # 7: text that is not a trace.
    "not a trace at all: ???",
]

TYPE_A = "com.example.model.EnrolmentResponse"
TYPE_B = "com.example.model.EventMessage"
TYPE_PATHS = {TYPE_A: ["response.refId", "response.results.referenceId"]}

REASON_CODES = [
    # code, description, category, category_source, failure_class, stage, section, numeric_id
    ("REF_DATA_NOT_FOUND", "Reference data not found", "BUSINESS_EXCEPTION", "declared", "", "DEDUP", "dedup", "2101"),
    ("KAFKA_PUBLISH_FAILED", "Kafka publish failed", "TECHNICAL_EXCEPTION", "declared", "", "PUBLISH", "infra", "9001"),
    ("PACKET_STATUS_INVALID", "Packet status invalid", "BUSINESS_VALIDATION_ERROR", "inferred", "", "STATUS", "status", "2203"),
    ("SCORE_THRESHOLD_BREACH", "Score threshold breached", "", "", "A", "MATCH", "match", "2305"),
]

# What a case's own log lines say about its failure (indexed like TRACES).
DECLARED_IN_LOGS = [
    "com.example.app.common.BusinessException: [REF_DATA_NOT_FOUND] missing",
    "publish error [KAFKA_PUBLISH_FAILED]",
    "NullPointerException at Strings.len",
    "javax.net.ssl.SSLHandshakeException: handshake",
    "WeirdFailure seen",
    "status check [PACKET_STATUS_INVALID]",
    "score [SCORE_THRESHOLD_BREACH]",
    "nothing named here",
]
